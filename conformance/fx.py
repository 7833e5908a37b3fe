"""Job-posting input derived from orders, customer and nation; the same SQL runs in Spark and DuckDB.

The given tables hold no keyword, JSON-LD block or closed signal, so queries on them alone would only ever
give empty answers. One row per order; every table below is read whole.
"""

FX_TEMPLATE = """
SELECT o_orderkey AS seq,
 CASE o_orderkey % 26
  WHEN 0 THEN 'Software Engineer Intern' WHEN 1 THEN 'Data Analyst Intern' WHEN 2 THEN 'Product Manager Intern'
  WHEN 3 THEN 'UX Designer Intern' WHEN 4 THEN 'Quant Trading Intern' WHEN 5 THEN 'SEO Specialist Intern'
  WHEN 6 THEN 'Office Coordinator' WHEN 7 THEN 'SOC Analyst Intern' WHEN 8 THEN 'Help Desk Intern'
  WHEN 9 THEN 'Full-Stack Intern' WHEN 10 THEN 'Security Intern' WHEN 11 THEN 'Python Intern'
  WHEN 12 THEN 'Sales Intern' WHEN 13 THEN 'Lab Intern' WHEN 14 THEN 'HR Intern'
  WHEN 15 THEN 'Analytics Intern' WHEN 16 THEN 'DevOps Intern' WHEN 17 THEN 'Network Intern'
  WHEN 18 THEN 'Entitédata Intern' WHEN 19 THEN 'Marketing Intern' WHEN 20 THEN '  software engineer intern '
  WHEN 21 THEN 'Security Data Analyst Intern' WHEN 22 THEN 'Program Manager Intern'
  WHEN 23 THEN 'Chemical Engineer Intern' WHEN 24 THEN 'Backend Intern' ELSE 'Summer Intern' END AS title,
 CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN upper(c_name) || ' ' ELSE c_name END AS company,
 CASE o_orderkey % 8 WHEN 0 THEN 'New York, NY' WHEN 1 THEN 'Austin, TX' WHEN 2 THEN 'San Francisco, CA'
  WHEN 3 THEN 'Remote' WHEN 4 THEN 'Remote / New York' WHEN 5 THEN 'Unknown' WHEN 6 THEN '' ELSE n_name END AS location,
 CASE o_custkey % 16
  WHEN 0 THEN '' WHEN 1 THEN 'Working on machine learning models.' WHEN 2 THEN 'manage candidate records'
  WHEN 3 THEN 'networking event planning' WHEN 4 THEN 'restore database backups'
  WHEN 5 THEN 'cybersecurity analytics SQL' WHEN 6 THEN 'it support and helpdesk'
  WHEN 7 THEN 'sales quota in a retail store' WHEN 8 THEN 'quantify the results; designated area'
  WHEN 9 THEN 'a graphic designer with the design team' WHEN 10 THEN 'python java react docker'
  WHEN 11 THEN 'windows hardware active directory' WHEN 12 THEN 'real estate insurance customer service'
  WHEN 13 THEN 'full stack web developer' WHEN 14 THEN 'accounting and finance'
  ELSE 'We desire a motivated intern' END AS description,
 'https://jobs.example.com/' || CAST(o_custkey % 700 AS VARCHAR(20)) AS posting_url,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date_posted,
 CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 1 THEN 'estimated' ELSE 'exact' END
  AS date_posted_confidence,
 CASE o_orderkey % 11 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 401
  WHEN 6 THEN 201 WHEN 7 THEN 0 ELSE 200 END AS status_code,
 CASE o_custkey % 7 WHEN 0 THEN '<p>Position Has Been Filled</p>' WHEN 1 THEN '<p>This posting has expired</p>'
  WHEN 2 THEN '<button type="submit">Send</button>' WHEN 3 THEN '<a>Apply Now</a>'
  WHEN 4 THEN '<p>position is no longer available</p>' WHEN 5 THEN '<p>role has been filled, job closed</p>'
  ELSE '<p>Great role.</p>' END AS html,
 CASE o_orderkey % 13 WHEN 0 THEN 'timeout' WHEN 1 THEN 'refused' ELSE '' END AS error,
 CAST(o_orderdate AS DATE) AS ordered_on
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

FX_DUCKDB = FX_TEMPLATE.format(orders="orders", customer="customer", nation="nation")

# An earlier run saw, and exported, what was ordered in these months.
EARLIER_FROM, EARLIER_TO = "1997-01-01", "1998-01-01"
AS_OF = "2001-08-01"
PER_QUERY, OVERALL, CHECKED = 20, 500, 500
URL_PREFIX = "https://jobs.example.com/"
