"""Operators of a training-data pipeline: archives, classifiers, duplicates, tokens, chats, packing."""
