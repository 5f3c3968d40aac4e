"""Stateful operators over framed streams."""
