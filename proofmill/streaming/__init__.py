"""A fact database is complete before it is checked: no operator is incremental, so this package holds none."""
