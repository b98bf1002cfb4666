"""Where statements come from."""
