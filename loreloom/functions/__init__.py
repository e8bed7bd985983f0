"""Part of the loreloom package."""
