"""From a question or a SQL text to a plan, an answer, an evaluation."""
