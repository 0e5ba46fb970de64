"""Distributed operators over long point tables."""
