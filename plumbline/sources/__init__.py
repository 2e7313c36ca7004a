"""Table readers, templates, catalog and result sinks."""
