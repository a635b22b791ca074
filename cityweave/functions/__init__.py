"""Column functions: geometry, time, text and routes."""
