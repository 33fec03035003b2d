"""Relations and statistics over case reports."""
