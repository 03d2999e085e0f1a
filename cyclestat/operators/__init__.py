"""DataFrame -> DataFrame operators on trip tables."""
