"""DataFrame operators.  Every function takes and returns DataFrames keyed by
``project_id``; nothing is collected to the driver."""
