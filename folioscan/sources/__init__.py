"""Where pages and chapters come from, and where results go."""
