"""Pieces that operators share: reported reasons, settings, scratch tables."""
