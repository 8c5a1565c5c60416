"""The checks that work on a stream of pages."""
