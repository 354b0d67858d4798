"""Part of marlstone; see README.md."""
