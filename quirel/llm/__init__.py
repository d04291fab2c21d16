"""Operators that prepare training corpora; nothing else in quirel imports them."""
