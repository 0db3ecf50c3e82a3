"""DataFrame operators over candidate pools, networks, facts and statistics."""
