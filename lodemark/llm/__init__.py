"""Training-data operators: filters, de-duplication, tokens, shards, chat."""
