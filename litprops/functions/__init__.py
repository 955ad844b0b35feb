from litprops.functions import arrays, hashing, text, variants

__all__ = ["arrays", "hashing", "text", "variants"]
