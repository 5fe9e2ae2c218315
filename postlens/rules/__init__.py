"""Small rules: plain Python values that operators take as parameters and callers may replace."""
