"""touchline: sports-match, betting-odds and corpus analytics as Spark jobs."""
