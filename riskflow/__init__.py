"""riskflow: message, link, file and sender risk scoring as Spark jobs."""
