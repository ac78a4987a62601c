"""Reading catalogue tables and snapshots, writing results."""
