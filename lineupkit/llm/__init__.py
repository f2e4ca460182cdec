"""Operations on training text and embeddings, each a Spark job over whole tables."""
