"""The same rules on streams of questions."""
