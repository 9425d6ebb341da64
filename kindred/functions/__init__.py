"""Part of kindred; see README.md."""
