"""Files for people and other tools."""
