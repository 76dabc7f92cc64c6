"""DataFrame -> DataFrame operators, generic over the input tables."""
