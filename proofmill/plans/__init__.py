"""From text to a checked plan: errors, the program's data classes, the parser, the catalog and its analysis."""
