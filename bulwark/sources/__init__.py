"""Reading and writing samples, reports and tables."""
