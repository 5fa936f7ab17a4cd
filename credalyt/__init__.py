"""Part of credalyt."""
