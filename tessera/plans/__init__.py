"""Named queries over the driver tables (``catalog``) and their DuckDB twins (``oracle``)."""
