"""The fixed lists as the SQL counterparts state them, on their own: a slip in the library's lists shows."""

# Keywords, signals, domains and query templates.

APPLY_SIGNALS = [
    'apply now', 'apply for this', 'submit application', 'apply online', 'type="submit"',
]

ATS_DOMAINS = {
    'workday': [
        '*.myworkdayjobs.com',
    ],
    'greenhouse': [
        'boards.greenhouse.io',
    ],
    'lever': [
        'jobs.lever.co',
    ],
    'smartrecruiters': [
        'jobs.smartrecruiters.com',
    ],
}

CATEGORY_KEYWORDS = {
    'data': [
        'data science', 'machine learning', 'deep learning', 'artificial intelligence', 'computer vision',
        'natural language', 'nlp', 'research scientist', 'ml engineer', 'data engineer', 'data analyst', 'analytics',
        'data',
    ],
    'product': [
        'product manager', 'product management', 'product owner', 'program manager',
    ],
    'design': [
        'user experience', 'user interface', 'ux researcher', 'ux designer', 'ui designer', 'graphic designer',
        'visual designer', 'design',
    ],
    'finance': [
        'quantitative', 'investment banking', 'financial analyst', 'accounting', 'finance', 'trading', 'quant',
    ],
    'marketing': [
        'digital marketing', 'content marketing', 'growth marketing', 'seo', 'copywriting', 'social media',
        'marketing',
    ],
    'software': [
        'software engineer', 'software developer', 'backend', 'frontend', 'front-end', 'back-end', 'fullstack',
        'full-stack', 'full stack', 'devops', 'site reliability', 'sre', 'platform engineer', 'mobile developer',
        'ios developer', 'android developer', 'web developer', 'api developer', 'infrastructure engineer',
    ],
}

CLOSED_SIGNALS = [
    'no longer available', 'position has been filled', 'job closed', 'not accepting applications',
    'requisition closed', 'this posting has expired', 'job listing is no longer', 'job has been filled',
    'position is no longer available', 'this job is no longer', 'listing has been removed', 'role has been filled',
]

NEGATIVE_KEYWORDS = [
    'sales', 'marketing', 'real estate', 'insurance', 'retail', 'cashier', 'barista', 'social media manager',
    'customer service', 'store', 'restaurant', 'hospitality',
]

TRACK_KEYWORDS = {
    'cyber': {
        'strong': [
            'cybersecurity', 'cyber security', 'information security', 'infosec', 'soc analyst', 'soc intern',
            'penetration test', 'pentest', 'security analyst', 'security engineer', 'network security',
            'vulnerability', 'threat intelligence', 'malware', 'forensics', 'incident response',
            'security operations', 'ethical hacking',
        ],
        'weak': [
            'security', 'cyber', 'firewall', 'compliance', 'audit',
        ],
    },
    'it': {
        'strong': [
            'help desk', 'helpdesk', 'desktop support', 'it support', 'systems administrator', 'sysadmin',
            'network administrator', 'it analyst', 'it technician', 'it specialist', 'service desk',
            'information technology intern',
        ],
        'weak': [
            'it intern', 'tech support', 'systems', 'network', 'infrastructure', 'windows', 'active directory',
            'hardware', 'troubleshoot',
        ],
    },
    'swe': {
        'strong': [
            'software engineer', 'software developer', 'swe intern', 'backend engineer', 'frontend engineer',
            'full stack', 'fullstack', 'web developer', 'application developer', 'mobile developer', 'ios developer',
            'android developer', 'devops', 'site reliability', 'platform engineer',
        ],
        'weak': [
            'developer', 'programmer', 'coding', 'python', 'java', 'javascript', 'react', 'node', 'backend',
            'frontend', 'api', 'kubernetes', 'docker',
        ],
    },
    'data': {
        'strong': [
            'data analyst', 'data scientist', 'data engineer', 'business intelligence', 'bi analyst',
            'machine learning', 'ml engineer', 'analytics engineer', 'data analytics', 'data science',
            'quantitative analyst',
        ],
        'weak': [
            'data', 'analytics', 'sql', 'etl', 'tableau', 'power bi', 'pandas', 'numpy', 'statistics', 'reporting',
            'dashboard',
        ],
    },
}

TRACK_QUERY_TEMPLATES = {
    'cyber': '("intern" OR "internship") (cybersecurity OR "information security" OR SOC OR "security analyst" OR "network security" OR "penetration test")',
    'it': '("intern" OR "internship") ("IT" OR "help desk" OR "systems" OR "desktop support" OR "network")',
    'swe': '("intern" OR "internship") ("software engineer" OR SWE OR backend OR frontend OR "full stack" OR developer)',
    'data': '("intern" OR "internship") (data OR analytics OR "data analyst" OR "business intelligence" OR SQL OR "machine learning")',
}
