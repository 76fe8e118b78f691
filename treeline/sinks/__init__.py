"""Where findings and reports go."""
