"""The models users run: staging -> intermediate -> marts, analyses, dashboards."""
