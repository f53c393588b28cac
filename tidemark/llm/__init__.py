"""Training-data operators over ``documents``, ``pages``, ``embeddings`` and ``benchmark``."""
