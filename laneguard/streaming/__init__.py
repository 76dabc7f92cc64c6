"""The batch operators applied to a ``readStream`` of the same schema."""
