"""Training-data operators over ``documents``, ``embeddings`` and ``pages``.

Nothing else in the library imports this subpackage.
"""
