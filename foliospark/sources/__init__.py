"""Reading inputs, replacing result tables, storing shared intermediates."""
