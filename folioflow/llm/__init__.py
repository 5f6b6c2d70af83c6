"""Training-data operators: near-dedup, archives, licences, quality, mixing, secrets, chat masks, packing."""
