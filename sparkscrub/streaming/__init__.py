"""Cell cleaners on streams."""
