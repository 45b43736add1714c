"""Operations of a training-data pipeline: each module holds one operator and its documented cases."""
