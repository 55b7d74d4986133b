from . import prompts, text, vectors

__all__ = ["prompts", "text", "vectors"]
