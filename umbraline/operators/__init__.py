"""Operators over tables of texts: detect, mask, vault, restore, messages, audit, evaluation."""
