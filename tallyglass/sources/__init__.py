"""Tables and files that queries, evaluations and prompts read or write."""
