"""Operations of a large-scale training-data pipeline. Nothing else in tagloom imports this package."""
