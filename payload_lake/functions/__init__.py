"""Column functions: JSON paths, text, time, classification and segment arithmetic."""
