"""Text and vector operators over the call logs and traffic profiles of ranks."""
