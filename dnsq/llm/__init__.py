"""Operations of a training-data pipeline: filters, near duplicates, language, packing, shards."""
