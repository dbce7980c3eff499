"""Where rows come from: literals, nested records, scripts, modules, overlays, Parquet and fact files."""
