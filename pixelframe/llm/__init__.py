"""Training-data operators: quality, mixing, URLs, near-duplicates, tokens, leaks, secrets, archives, chats.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
