"""CSV output that a spreadsheet cannot mistake for formulas."""
