"""Where documents and questions come from."""
