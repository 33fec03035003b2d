"""Classification models over case features."""
