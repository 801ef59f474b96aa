"""Operations of a training-data pipeline. Nothing else in recordloom imports this subpackage."""
