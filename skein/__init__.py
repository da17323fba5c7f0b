"""skein: a PySpark-native analytics engine for coding-agent histories."""
