"""Distributed operators over flow tables."""
