"""Column expressions: text, privacy, safety, intents."""
