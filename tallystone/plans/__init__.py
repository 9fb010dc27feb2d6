"""Named queries over the driver tables, with the SQL to hold them against."""
