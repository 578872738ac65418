"""The same transforms over streams."""
