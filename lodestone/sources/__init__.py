"""Files to text, and evaluation questions."""
