"""What is known of log sources: markers, lines that matter, and how lines go on."""

from __future__ import annotations

# Names, markers, patterns and modes of the sources that have patterns or a mode of their own.
#: source -> markers, in the order in which they are tried. More sources are a parameter: ``Options.sources``, or the configuration file.
CATALOG: dict[str, list[str]] = {
    "vitest": ["vitest"],
    "jest": ["jest"],
    "mocha": ["mocha"],
    "cypress": ["cypress"],
    "webpack": ["webpack"],
    "vite": ["vite"],
    "rollup": ["rollup"],
    "esbuild": ["esbuild"],
    "typescript": ["typescript", "tsc", "ts2322", "ts18048"],
    "eslint": ["eslint"],
    "npm": ["npm err!", "npm warn", "npm run"],
    "pnpm": ["pnpm err!", "pnpm"],
    "yarn": ["yarn error", "yarn run"],
    "pytest": ["pytest", "tests/", "assertionerror: assert"],
    "pip": ["pip install", "pip uninstall"],
    "django": ["django", "manage.py"],
    "flask": ["flask app"],
    "fastapi": ["fastapi", "uvicorn"],
    "celery": ["celery"],
    "maven": ["maven", "mvn ", "mojofailureexception"],
    "gradle": ["gradle", "task :", "build failed with an exception"],
    "bazel": ["bazel", "build did not complete successfully"],
    "cmake": ["cmake error", "cmakefiles"],
    "junit": ["junit"],
    "spring-boot": ["spring", "springboot"],
    "logback": ["logback"],
    "go-test": ["go test", "--- fail:"],
    "go-build": ["go build", "go: downloading"],
    "cargo": ["cargo build", "cargo test"],
    "rustc": ["rustc", "error[e"],
    "msbuild": ["msbuild", "error msb"],
    "phpunit": ["phpunit"],
    "composer": ["composer"],
    "bundler": ["bundle install", "bundler"],
    "rspec": ["rspec"],
    "docker": ["docker", "dockerfile"],
    "buildkit": ["buildkit", "#0 [internal]"],
    "containerd": ["containerd"],
    "kubernetes": ["kubernetes", "kubectl", "k8s"],
    "helm": ["helm"],
    "github-actions": ["github actions", "##[error]", "::error::"],
    "gitlab-ci": ["gitlab-ci", "running with gitlab-runner"],
    "jenkins": ["jenkins", "[pipeline]"],
    "circleci": ["circleci"],
    "azure-pipelines": ["azure pipelines", "##vso"],
    "teamcity": ["teamcity", "##teamcity"],
    "buildkite": ["buildkite"],
    "trivy": ["trivy", "vulnerability", "cve-"],
    "snyk": ["snyk"],
    "grype": ["grype"],
    "semgrep": ["semgrep"],
    "gitleaks": ["gitleaks"],
    "checkov": ["checkov"],
    "bandit": ["bandit"],
    "nginx": ["nginx"],
    "apache-httpd": ["httpd", "apache/", "apache2", "mod_jk", "scoreboard slot"],
    "postgresql": ["postgres", "postgresql"],
    "mysql": ["mysql"],
    "mongodb": ["mongodb", "mongod"],
    "redis": ["redis"],
    "cockroachdb": ["cockroachdb"],
    "kafka": ["kafka"],
    "rabbitmq": ["rabbitmq"],
    "aws-sqs": ["aws sqs", "amazon sqs"],
    "gcp-pubsub": ["pub/sub", "google pubsub", "gcp pubsub"],
    "cloudformation": ["cloudformation"],
    "terraform": ["terraform"],
    "terragrunt": ["terragrunt"],
    "ansible": ["ansible"],
    "pulumi": ["pulumi"],
    "vault": ["vault"],
    "aws-lambda": ["aws lambda", "lambda"],
    "cloudwatch": ["cloudwatch"],
    "gcp-cloud-run": ["cloud run"],
    "azure-functions": ["azure functions"],
    "aws-ecs": ["aws ecs", "amazon ecs"],
    "cloudflare": ["cloudflare"],
    "vercel": ["vercel"],
    "prometheus": ["prometheus"],
    "grafana": ["grafana"],
    "loki": ["loki"],
    "datadog": ["datadog"],
    "newrelic": ["new relic"],
    "sentry": ["sentry"],
    "keycloak": ["keycloak"],
    "auth0": ["auth0"],
    "express": ["express", "expressjs", "express server"],
    "fastify": ["fastify", "fastify server"],
    "nestjs": ["nestjs", "@nestjs", "nest.js"],
    "nextjs": ["next.js", "nextjs", "next build", "next start", "next dev"],
    "nuxt": ["nuxt", "nuxt3", "nuxt build", "nuxt generate"],
    "hono": ["hono", "honojs", "hono server"],
    "pino": ["pino", "pino pretty", "pino.info"],
    "winston": ["winston", "winston logger"],
    "bunyan": ["bunyan", "bunyan logger"],
    "log4j": ["log4j", "org.apache.log4j"],
    "slf4j": ["slf4j", "org.slf4j"],
    "structlog": ["structlog", "python-structlog"],
    "loguru": ["loguru", "loguru.py"],
    "react-native": ["react native", "react-native", "reactnative"],
    "flutter": ["flutter", "flutter test", "flutter build"],
    "electron": ["electron", "electron-builder", "electron-forge"],
    "wordpress": ["wordpress", "wp-content", "wp-admin", "wp-includes"],
    "drupal": ["drupal", "drupal.org"],
    "strapi": ["strapi", "strapi start"],
    "shopify": ["shopify", "shopify-cli"],
    "tomcat": ["tomcat", "apache tomcat", "catalina.start"],
    "jetty": ["jetty", "eclipse jetty", "jetty.server"],
    "ruff": ["ruff", "ruff check", "ruff format"],
    "mypy": ["mypy", "mypy: error:", "mypy: warning:"],
    "pyright": ["pyright", "pyright -"],
    "pylint": ["pylint", "pylint --"],
    "aiohttp": ["aiohttp", "aiohttp.server"],
    "sanic": ["sanic", "sanic server"],
    "echo-framework": ["echo lab", "labstack/echo", "echo v4"],
    "fiber": ["fiber", "gofiber", "fiber v2"],
    "rocket": ["rocket.rs", "rocket rust", "rocket server"],
    "axum": ["axum", "tokio-rs/axum", "axum router"],
    "prisma": ["prisma", "prisma migrate", "prisma generate", "prisma db"],
    "drizzle-orm": ["drizzle-orm", "drizzle kit", "drizzle push"],
    "typeorm": ["typeorm", "typeorm query", "typeorm:"],
    "sequelize": ["sequelize", "sequelize-cli"],
    "knex": ["knex", "knexfile", "knex migrate"],
    "sqlalchemy": ["sqlalchemy", "sqlalchemy.orm"],
    "cloudflare-workers": ["cloudflare workers", "wrangler", "wrangler dev"],
    "openai-api": ["openai", "openai api", "openai.error"],
    "huggingface": ["huggingface", "hugging face", "huggingface.co"],
    "ollama": ["ollama", "ollama run", "ollama serve"],
    "vllm": ["vllm", "vllm serve", "vllm engine"],
    "clerk": ["clerk", "clerk.dev"],
    "sphinx": ["sphinx", "sphinx-build", "sphinx-autogen"],
    "bullmq": ["bullmq", "bull mq", "bullmq queue"],
    "aws-cdk": ["aws cdk", "cdk deploy", "cdk synth", "cdk diff"],
    "langchain": ["langchain", "langchain.py", "langchain.js"],
    "velero": ["velero", "velero backup", "velero restore"],
    "restic": ["restic", "restic backup", "restic restore"],
}
#: source -> (pattern, flags) of lines that its presence makes important.
BOOSTS: dict[str, list[tuple[str, str]]] = {
    "typescript": [(r"\bTS\d{4}\b", "")],
    "pytest": [(r"^E\s+", ""), (r"\bFAILED\b", "")],
    "nginx": [(r"\[(?:error|crit|alert|emerg)\]", "i")],
    "apache-httpd": [(r"\[(?:error|crit|alert|emerg)\]", "i"), (r"\bAH\d{5}\b", ""), (r"\b(?:Directory index forbidden|client denied|mod_jk)\b", "i")],
    "kubernetes": [(r"\b(?:BackOff|Failed|ErrImagePull|CrashLoopBackOff)\b", "")],
    "github-actions": [(r"^::(?:error|warning)\b", "")],
    "gradle": [(r"\b(?:Execution failed|What went wrong|BUILD FAILED)\b", "i")],
    "maven": [(r"\b(?:BUILD FAILURE|Failed to execute goal|Compilation failure)\b", "i")],
    "bazel": [(r"\b(?:BUILD FAILED|build did not complete successfully)\b", "i")],
    "webpack": [(r"\b(?:Module not found|Can't resolve|Module build failed|BUILD FAILED)\b", "i")],
    "vite": [(r"\b(?:Build failed|Transform failed|Internal server error)\b", "i")],
    "esbuild": [(r"\b(?:Build failed|error:\s|ERROR:)\b", "")],
    "rollup": [(r"\b(?:!\s|Circular dependency|Could not resolve)\b", "")],
    "cargo": [(r"\b(?:error\[E\d{4}\]|error: could not compile|could not compile `)", "")],
    "rustc": [(r"\berror\[E\d{4}\]\b", "")],
    "cmake": [(r"\b(?:CMake Error|CMakeFiles|cmake failed)\b", "i")],
    "msbuild": [(r"\b(?:error MSB\d{4}|Build FAILED)\b", "i")],
    "make": [(r"\b(?:make: \*\*\*|make\[|Error \d+\])\b", "")],
    "go-build": [(r"\b(?:go: |build failed|cannot find package)\b", "i")],
    "npm": [(r"\bnpm\s+ERR!", "i")],
    "pnpm": [(r"\bpnpm\s+ERR!", "i")],
    "yarn": [(r"\byarn\s+error\b", "i")],
    "pip": [(r"\b(?:ERROR: Could not find a version|ERROR: No matching distribution)\b", "")],
    "bundler": [(r"\b(?:Could not find gem|Bundler::|Gem::ConflictError)\b", "")],
    "composer": [(r"\b(?:Composer\\|Installation failed|Root package)\b", "")],
    "jest": [(r"\b(?:●\s|Tests:\s+\d+\s+failed|AssertionError:)\b", "")],
    "vitest": [(r"\b(?:FAIL\s+|AssertionError:|Test Files\s+\d+\s+failed)\b", "")],
    "mocha": [(r"\b(?:AssertionError|Error:) \d+ (?:failing|passing)\b", "")],
    "go-test": [(r"\b---\s*FAIL:", "")],
    "junit": [(r"\b(?:Tests run: \d+.*Failures: [1-9]|FAILED)\b", "")],
    "rspec": [(r"\b(?:Failures:|expected:|got:)\b", "")],
    "phpunit": [(r"\b(?:FAILURES!|Tests: \d+|Assertions: \d+)\b", "")],
    "docker": [(r"\b(?:Error response from daemon|failed to build|failed to push|manifest.*not found)\b", "i")],
    "buildkit": [(r"\b(?:error:|failed to solve|canceled)\b", "")],
    "containerd": [(r"\b(?:failed to start container|OCI runtime|runc)\b", "i")],
    "helm": [(r"\b(?:Error: UPGRADE FAILED|Error: INSTALLATION FAILED|Error: uninstall|Error: release.*failed)\b", "i")],
    "terraform": [(r"\b(?:Error: |Error applying|Terraform.*failed)\b", "i")],
    "terragrunt": [(r"\b(?:Error: |Module.*error)\b", "i")],
    "ansible": [(r"\b(?:fatal: \[|FAILED!|UNREACHABLE!)\b", "")],
    "pulumi": [(r"\b(?:Pulumi\.error|error: update failed|Diagnostics:)\b", "i")],
    "aws-cdk": [(r"\b(?:CdkSynthError|cdk deploy failed|ValidationError|No stack named)\b", "i")],
    "postgresql": [(r"\b(?:FATAL:|ERROR:|PG::|relation.*does not exist)\b", "i")],
    "mysql": [(r"\b(?:ERROR \d{4}|Can't connect|Access denied for user)\b", "i")],
    "redis": [(r"\b(?:DENIED|Connection refused|ERR |WRONGTYPE|READONLY)\b", "")],
    "mongodb": [(r"\b(?:MongoServerSelectionError|MongoNetworkError|not master|NotWritablePrimary)\b", "i")],
    "kafka": [(r"\b(?:Broker may not be available|Connection to node.*could not be established|UNKNOWN_TOPIC_OR_PARTITION)\b", "i")],
    "rabbitmq": [(r"\b(?:connection refused|broker unreachable|channel error|PRECONDITION_FAILED)\b", "i")],
    "cockroachdb": [(r"\b(?:SQLSTATE|restart transaction|RETRY_WRITE_TOO_OLD)\b", "i")],
    "express": [(r"\b(?:Error: Cannot find module|TypeError:.*Router|Error: EADDRINUSE|Error: listen EACCES)\b", "")],
    "fastify": [(r"\b(?:FST_ERR|fastify error|plugin initialization failed)\b", "i")],
    "nestjs": [(r"\b(?:NestError|Nest can't resolve dependencies|Circular dependency detected)\b", "i")],
    "nextjs": [(r"\b(?:Error: Cannot resolve dependency|Error: Build failed|Module not found|Error: > Build failed)\b", "")],
    "nuxt": [(r"\b(?:Nuxt Build Error|Cannot start nuxt|Fatal error)\b", "i")],
    "hono": [(r"\b(?:TypeError: Cannot read properties|HonoError)\b", "")],
    "prisma": [(r"\b(?:P\d{4,5}|PrismaClientKnownRequestError|PrismaClientValidationError|PrismaClientInitializationError)\b", "")],
    "drizzle-orm": [(r"\b(?:DrizzleKitError|drizzle.*error|MigrationError)\b", "i")],
    "typeorm": [(r"\b(?:QueryFailedError|EntityMetadataNotFound|ConnectionNotFoundError|DriverPackageNotInstalledError)\b", "i")],
    "sequelize": [(r"\b(?:SequelizeConnectionError|SequelizeDatabaseError|SequelizeValidationError)\b", "i")],
    "knex": [(r"\b(?:MigrationLockError|KnexTimeoutError|Knex:error)\b", "i")],
    "django": [(r"\b(?:django\.core\.exceptions|django\.db\.utils|OperationalError|ImproperlyConfigured)\b", "i")],
    "fastapi": [(r"\b(?:fastapi\.exceptions|HTTPException|ValidationError|RequestValidationError)\b", "i")],
    "flask": [(r"\b(?:werkzeug\.exceptions|flask\.abort|Internal Server Error)\b", "i")],
    "celery": [(r"\b(?:celery\.exceptions|Task.*raised unexpected|WorkerLostError)\b", "i")],
    "sqlalchemy": [(r"\b(?:sqlalchemy\.exc\.|OperationalError|IntegrityError|ProgrammingError)\b", "i")],
    "eslint": [(r"\b\d+:\d+\s+error\s|\beslint.*error\b", "i")],
    "semgrep": [(r"\b(?:semgrep finding|severity:(?:ERROR|WARNING))\b", "i")],
    "gitleaks": [(r"\bsecret detected\b", "i")],
    "trivy": [(r"\b(?:CRITICAL|HIGH):\s|CVE-\d{4}-\d{4,7}\b", "")],
    "snyk": [(r"\b(?:High severity|Critical severity|introduced by)\b", "i")],
    "grype": [(r"\b(?:CRITICAL\s+CVE-|HIGH\s+CVE-|NAME\s+INSTALLED\s+FIXED-IN)\b", "")],
    "checkov": [(r"\b(?:CKV_|Checkov.*failed)\b", "")],
    "bandit": [(r"\b(?:Issue: \[B\d{3}|Test results:.*issues)\b", "")],
    "mypy": [(r"\b(?:mypy: error:|mypy: warning:|Incompatible types|has incompatible type)\b", "")],
    "ruff": [(r"\b(?:ruff\s+(?:check|format)|F\d{3,4}|E\d{3,4}|RUF\d{3})\b", "")],
    "pylint": [(r"\b(?:pylint\s+|E\d{4}:|W\d{4}:|C\d{4}:|R\d{4}:)\b", "")],
    "circleci": [(r"\b(?:Spin Cancelled|Step failed|job was not approved)\b", "")],
    "jenkins": [(r"\b(?:\[Pipeline\]\s*\[ERROR\]|Stage .* failed|script returned exit code [1-9])\b", "")],
    "gitlab-ci": [(r"\b(?:ERROR: Job failed|job failed|script returned exit code [1-9])\b", "")],
    "teamcity": [(r"\b##teamcity\[(?:buildProblem|compilationFinished)\b", "")],
    "azure-pipelines": [(r"\b##vso\[task\.(?:LogIssue|Complete)\b", "")],
    "buildkite": [(r"\b(?:buildkite.*failed|command failed)\b", "i")],
    "aws-lambda": [(r"\b(?:Task timed out|ERROR Invoke Error|Runtime\.ExitError|Process exited before completing)\b", "i")],
    "gcp-cloud-run": [(r"\b(?:Cloud Run.*failed|Revision.*failed|Container failed to start|Ready condition status)\b", "i")],
    "azure-functions": [(r"\b(?:System\.TimeoutException|FunctionInvocationException|Host threshold exceeded)\b", "i")],
    "cloudformation": [(r"\b(?:ROLLBACK_COMPLETE|CREATE_FAILED|UPDATE_FAILED|DELETE_FAILED)\b", "")],
    "cloudwatch": [(r"\b(?:Alarm|INSUFFICIENT_DATA|State change)\b", "")],
    "aws-ecs": [(r"\b(?:service.*failed|Task failed|unable to place a task)\b", "i")],
    "datadog": [(r"\b(?:datadog ERROR|datadog CRITICAL|datadog WARN)\b", "i")],
    "sentry": [(r"\b(?:failed to send event|sentry\.captureException|Error exporting spans)\b", "i")],
    "prometheus": [(r"\b(?:target.*down|scrape.*failed|rule evaluation error|Alertmanager)\b", "i")],
    "grafana": [(r"\b(?:grafana.*alert|alerting evaluation error|Dashboard.*error|provisioning error)\b", "i")],
    "loki": [(r"\b(?:loki.*error|logql.*error|ingester.*failed)\b", "i")],
    "newrelic": [(r"\b(?:NR-\d+|new relic.*error|NewRelic.*error)\b", "i")],
    "aws-sqs": [(r"\b(?:SQS.*error|QueueDoesNotExist|ReceiptHandleIsInvalid)\b", "i")],
    "gcp-pubsub": [(r"\b(?:pubsub.*error|DeadlineExceeded|UNAVAILABLE)\b", "i")],
    "bullmq": [(r"\b(?:StalledJobError|job.*failed|BullMQ.*error|WaitingChildrenError)\b", "i")],
    "openai-api": [(r"\b(?:Rate limit exceeded|RateLimitError|context_length_exceeded|invalid_request_error|insufficient_quota)\b", "i")],
    "ollama": [(r"\b(?:model not found|Error: |CUDA error|Error: llama)\b", "")],
    "vllm": [(r"\b(?:CUDA out of memory|OOM|Error: Failed to load model|tensor parallel)\b", "i")],
    "langchain": [(r"\b(?:OutputParserError|LangChain.*error|Chain.*failed|Agent.*error)\b", "i")],
    "huggingface": [(r"\b(?:HubConnectionError|ModelNotFoundError|RepositoryNotFoundError|HFValidationError)\b", "i")],
    "keycloak": [(r"\b(?:Failed to authenticate|invalid_grant|unauthorized_client|token_introspection_failed)\b", "i")],
    "vault": [(r"\b(?:permission denied|failed to seal|Error making API request|secret is missing)\b", "i")],
    "clerk": [(r"\b(?:ClerkAuthenticationError|ClerkAPIError|InvalidSessionError)\b", "i")],
    "auth0": [(r"\b(?:Auth0Error|Invalid token|access_denied|unauthorized)\b", "i")],
    "pino": [(r'\b(?:pino\.|"level":(?:50|60))\b', "")],
    "log4j": [(r"\b(?:org\.apache\.log4j|log4j:ERROR|log4j:WARN)\b", "")],
    "slf4j": [(r"\b(?:org\.slf4j|LoggerFactory|Failed to load class)\b", "")],
    "winston": [(r"\b(?:winston.*error|winston\.error)\b", "i")],
    "cloudflare": [(r"\b(?:cloudflare.*error|cf-ray|Error \d{3,4})\b", "i")],
    "cloudflare-workers": [(r"\b(?:Workers.*error|wrangler.*error|Service bindings error)\b", "i")],
    "vercel": [(r"\b(?:vercel.*error|Vercel.*failed|Deployment error)\b", "i")],
    "rocket": [(r"\b(?:Rocket\.error|Rocket has crashed|launch fairing failed)\b", "")],
    "axum": [(r"\b(?:axum::|axum error|hyper::Error)\b", "")],
    "echo-framework": [(r"\b(?:echo v4 handler panic|labstack/echo|echo\.HTTPError)\b", "")],
    "fiber": [(r"\b(?:fiber\.Error|fiber\.RequestTimeoutError|fiber v2.*error)\b", "")],
    "react-native": [(r"\b(?:Unable to resolve module|bundling failed|Metro error|ReactNativeFirebaseError)\b", "")],
    "flutter": [(r"\b(?:flutter.*error|Dart error|Unhandled Exception|FlutterError)\b", "i")],
    "electron": [(r"\b(?:electron-builder.*error|Cannot find module 'electron'|Error: electron)\b", "")],
    "shopify": [(r"\b(?:ShopifyError|ShopifyAPIError|GraphQL.*error|ShopifyCLI.*error)\b", "i")],
    "wordpress": [(r"\b(?:PHP Fatal error:|PHP Parse error:|wp-db\.php|WPDB error)\b", "i")],
    "drupal": [(r"\b(?:Drupal\\|PluginNotFoundException|Uncaught PHP Exception)\b", "")],
    "strapi": [(r"\b(?:Strapi.*error|Error: Connection refused to database)\b", "i")],
    "velero": [(r"\b(?:VeleroBackupError|BackupStorageLocation|backup failed)\b", "i")],
    "restic": [(r"\b(?:ResticRepositoryError|Fatal: unable to open repo|Fatal: |repo already locked)\b", "")],
}
#: source -> how its lines go on.
MODES: dict[str, str] = {
    "pytest": "python",
    "django": "python",
    "flask": "python",
    "celery": "python",
    "aiohttp": "python",
    "sanic": "python",
    "tornado": "python",
    "structlog": "python",
    "loguru": "python",
    "ruff": "python",
    "mypy": "python",
    "pyright": "python",
    "pylint": "python",
    "sphinx": "python",
    "jest": "node",
    "vitest": "node",
    "mocha": "node",
    "cypress": "node",
    "express": "node",
    "fastify": "node",
    "nestjs": "node",
    "nextjs": "node",
    "pino": "node",
    "winston": "node",
    "bunyan": "node",
    "maven": "java",
    "gradle": "java",
    "spring-boot": "java",
    "junit": "java",
    "logback": "java",
    "log4j": "java",
    "tomcat": "java",
    "jetty": "java",
    "go-test": "go",
    "go-build": "go",
    "go-fmt": "go",
    "cargo": "rust",
    "rustc": "rust",
}
