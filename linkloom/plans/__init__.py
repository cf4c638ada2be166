"""Plan-level helpers: sessions and shared scratch tables."""
