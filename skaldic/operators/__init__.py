"""DataFrame operators: scoring, result tables and boards, raw outputs, transcription."""
