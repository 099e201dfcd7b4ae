"""Rule sets as data: vocabularies, flags, scopes and weights."""
