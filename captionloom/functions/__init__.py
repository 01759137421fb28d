from captionloom.functions import hashing, text, tokens, vectors

__all__ = ["hashing", "text", "tokens", "vectors"]
