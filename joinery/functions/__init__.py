"""Part of joinery."""
