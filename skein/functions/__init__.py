"""Part of the skein analytics engine."""
