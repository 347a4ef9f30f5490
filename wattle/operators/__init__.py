"""DataFrame -> DataFrame operators over meter readings."""
