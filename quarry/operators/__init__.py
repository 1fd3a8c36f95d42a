"""DataFrame -> DataFrame operators (no collect, no driver loops)."""
