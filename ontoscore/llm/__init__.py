"""Training-data operators: deduplication, scoring, mixing, archiving, search and chat formatting."""
