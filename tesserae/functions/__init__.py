"""Column functions: tokens, stems, strings."""
