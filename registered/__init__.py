"""The queries the driver runs, each next to the SQL it is compared with."""
