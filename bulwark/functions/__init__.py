"""Column functions: text measures, regular expressions, normalization and result structs."""
