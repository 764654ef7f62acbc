from .bytes import ascii_lower, as_bytes, byte_text, fnv1a64, overlapping_regex

__all__ = ["ascii_lower", "as_bytes", "byte_text", "fnv1a64", "overlapping_regex"]
