"""Batches that arrive one after another."""
