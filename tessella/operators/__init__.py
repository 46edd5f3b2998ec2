"""Rules and operators over token, edge, document and entity tables."""
