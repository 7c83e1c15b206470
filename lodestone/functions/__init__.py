"""Part of lodestone; see README.md."""
