"""Operators over pixel, region, palette and polyline relations."""
