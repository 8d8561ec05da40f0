"""Part of courierlens; see README.md."""
