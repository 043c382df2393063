"""Part of sparkwright; see the README for the catalogue."""
