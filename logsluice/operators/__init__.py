"""DataFrame operators: parsing, record building, ordered flow, delivery, quality, merging."""
