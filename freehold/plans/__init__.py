"""Domain views over the driver's tables, the registered queries and the SQL they are held against."""
